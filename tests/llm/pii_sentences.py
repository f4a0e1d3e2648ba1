"""Sentences written by hand, none of them from the composer, with the kinds of personal information they hold.

``SEEN`` were looked at while the training texts were written, ``HELD_OUT`` only after.
"""

N, E, P, I, A = "NAME", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS"
SEEN = [
    ("Write to jane_doe@mail.example for details", {E}), ("Write to jane.doe@mail.example for details", {E}), ("Mail jane.doe@mail.example", {E}), ("The invoice went to accounts@northwind.example last Friday.", {E}), ("Could you forward this to li.wei@corp.example and cc me?", {E}),
    ("We met Marlene Obuya yesterday near the river and Obuya asked for a copy of the letter", {N}), ("My neighbour Kwame Mensah can be reached at 020 7946 0958.", {N, P}), ("Mein Name ist Jürgen Vogel und ich wohne in Köln.", {N}), ("Yesterday Amara Okafor signed the lease", {N}),
    ("I spoke with Dr. Helena Sørensen about the results", {N}), ("Le pedí a Lucía Fernández que llame al +34 612 345 678", {N, P}), ("According to Tomasz Zielinski, the meeting was moved", {N}), ("Ask Priya Raman; Raman has the spare key", {N}), ("The report by Chidi Eze was late again", {N}),
    ("Please ring me back (+1 415-555-0133) after lunch", {P}), ("You can text 9876543210 any time", {P}), ("She moved to 48 Willow Avenue, Bristol last spring", {A}), ("Ship the parcel to P.O. Box 1182, Portland 97207 instead", {A}), ("Send the keys to Flat 7B, 112 Garden Lane, Leeds 55120 by Tuesday", {A}),
    ("Her passport K8812345 expires in June", {I}), ("The SSN on the form was 912-34-5678, which looks wrong", {I}), ("Our tax number is AFGPK4821L and we filed in March", {I}),
    ("The river Thames rises near Kemble", set()), ("We stayed at the Grand Hotel in Vienna", set()), ("On Monday the Office of Records opens at nine", set()), ("Order 4411 2298 7765 was shipped on 12 March", set()), ("Version 4.11.2 fixes the login page", set()), ("The University of Leeds has 38,000 students", set()),
    ("Click Save Changes to continue", set()), ("See section 12 of the Privacy Policy", set()), ("Pay 1,299.00 by 30 April", set()), ("Die Rechnung liegt im Büro auf dem Tisch", set()), ("Follow @nightowl for updates", set()), ("Tracking number 1Z9994482", set()), ("The New Year begins on a Thursday", set()),
    ("Please read the letter before you come back to the office", set()), ("La Plaza Mayor está cerrada hoy", set()), ("Windows 11 and Office 365 are installed", set()), ("Reference INV-2024-00817 is overdue", set()), ("Room 204, second floor", set()),
]
HELD_OUT = [
    ("Her new address for mail is nadia.k@fastpost.example, the old one bounces", {E}), ("bounce from ops+alerts@relay.test at 04:11", {E}), ("If it fails again, tell support@lumen.example.", {E}), ("You wrote to HELPDESK@CITY.EXAMPLE twice", {E}), ("Her username was the same as tom_99@webmail.example", {E}),
    ("reach us under office [at] firm [dot] example", {E}), ("Schreib bitte an info@verein.example", {E}), ("Escríbeme a marta.gil@correo.example mañana", {E}), ("(from: qa@build.test)", {E}), ("sales@shop.example or press 2", {E}), ("Both a.b@c.example and d.e@f.example were blocked", {E}),
    ("After six you will find me on +44 7700 900118", {P}), ("Her landline is (212) 555-0187", {P}), ("The driver can be called under 07700 900461 until noon", {P}), ("Wrong number? Try 303-555-0142", {P}), ("Ruf mich unter +49 171 2345678 an", {P}), ("Mi teléfono nuevo es +34 655 210 987", {P}), ("WhatsApp: +91 98201 44556", {P}),
    ("I left a voicemail at 617.555.0199 this morning", {P}), ("The nurse's pager, 408-555-0111, is off", {P}), ("sms to 8765432109 failed", {P}), ("Hotline 415-555-0175 is free of charge", {P}),
    ("They found passport N4471902 on the train", {I}), ("His PAN, BQRPT6612M, was rejected", {I}), ("SSN 987-65-4321 belongs to a test account", {I}), ("Is DKLMN5543A still your tax number?", {I}), ("the clerk typed 923-11-8844 into the wrong box", {I}), ("Passport no. R7719034 was renewed in Lima", {I}), ("Card holder id 7412 8536 0906 was checked twice", {I}),
    ("aadhaar 741285360906 could not be verified", {I}), ("We still miss a copy of passport T5540127", {I}), ("the form lists AHWPD2290F and nothing else", {I}),
    ("The couch goes to 221 Baker Street, London", {A}), ("He lives above the shop at 17 Harbour Road, Cork", {A}), ("Our office moved to 500 Lakeview Drive, Madison 53703 in May", {A}), ("Pickup is at 9 Mill Lane, Oxford", {A}), ("Return it to PO Box 2204, Denver 80202", {A}), ("Wir wohnen jetzt in der Gartenstraße 12, 50667 Köln", {A}),
    ("La tienda está en Calle Mayor 18, 28013 Madrid", {A}), ("Flat 3A, 88 Temple Lane, Pune 411001 has two keys", {A}), ("the van stopped at 1420 Cedar Court, Austin 78701", {A}), ("Invoice address: 36 Station Road, York", {A}),
    ("Somebody told Ingrid Halvorsen about the delay", {N}), ("The keys are with Mr. Adeyemi", {N}), ("Samuel Osei fixed the boiler on Tuesday", {N}), ("I gave the parcel to Mei-Ling Chen at the door", {N}), ("Both Rafael Ortega and Nina Kowalska signed", {N}), ("Professor Dubois gave the talk; Dubois was late", {N}), ("Signed: Oluwaseun Balogun", {N}),
    ("Frau Schneider hat heute angerufen", {N}), ("Ayer hablé con Carmen Ruiz sobre el piso", {N}), ("the landlord, Patrick O'Neill, wants the rent", {N}), ("Do you know whether Leila Haddad has left?", {N}), ("A letter from K. Yamamoto arrived", {N}), ("When Giulia Bianchi called, nobody answered", {N}), ("Thanks, Dmitri Volkov", {N}),
    ("The museum opens at ten and closes at six", set()), ("Berlin and Paris are both far away", set()), ("The Ministry of Health published new rules", set()), ("Invoice 20240117 was cancelled", set()), ("Flight LH 1842 lands at 14:25", set()), ("We sold 12,500 units in October", set()), ("The meeting is in Room B12 on Friday", set()),
    ("Build 20240511 broke the export", set()), ("Press Ctrl and F to search", set()), ("Order no. 8834 2210 9917 is on its way", set()), ("Der Zug nach Hamburg fährt um neun", set()), ("El museo abre los lunes", set()), ("The Pacific Ocean is deep", set()), ("Ask @support_bot in the channel", set()), ("The total is 3,450.75 with tax", set()), ("I read the Sunday Times on the train", set()),
    ("Our team won 3 to 1", set()), ("Chapter 7 starts on page 212", set()), ("It was cold, wet and windy", set()), ("Serial XK-2291-77 is out of stock", set()), ("The Golden Gate Bridge is closed", set()), ("Sign in to see your orders", set()),
]
